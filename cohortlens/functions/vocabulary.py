"""Word lists that decide what a label or a column name means."""

from __future__ import annotations

# Labels (trimmed, lower case) that count as the event.
POSITIVE_LABELS = [
    "có", "co", "yes", "y", "true", "1", "left", "exited", "attrition", "resigned",
    "nghỉ việc", "nghi viec", "nghỉ_việc", "nghi_viec",
]

# Labels (trimmed, lower case) that count as no event.
NEGATIVE_LABELS = [
    "không", "khong", "no", "n", "false", "0", "stayed", "active", "ở lại", "o lai", "current",
]

# Overtime levels that read as yes and as no.
OVERTIME_YES = ["có", "yes", "y", "true", "1"]
OVERTIME_NO = ["không", "no", "n", "false", "0"]

# Names each analytical role goes by.  One spelling per name is
# enough, since names are compared without case, accents and separators.
ROLE_ALIASES = {
    "target": ["Nghỉ_việc", "Attrition", "Left", "Exited", "Turnover", "EmployeeStatus", "Status",
               "Churn", "Resigned"],
    "id": ["Mã_nhân_viên", "EmployeeID", "EmployeeNumber", "EmpID"],
    "age": ["Tuổi", "Age"],
    "gender": ["Giới_tính", "Gender", "Sex"],
    "marital": ["Tình_trạng_hôn_nhân", "MaritalStatus", "Marriage"],
    "location": ["DiaDiemLamViec", "Location", "City", "OfficeLocation"],
    "contract": ["LoaiHopDong", "ContractType", "EmploymentType"],
    "education": ["Trình_độ_học_vấn", "Education", "EducationLevel"],
    "field": ["LinhVucDaoTao", "Chuyên_ngành_đào_tạo", "EducationField", "Major"],
    "department": ["Phòng_ban", "Department", "Dept"],
    "job_role": ["ViTriCongViec", "Vai_trò_công_việc", "JobRole", "Position"],
    "job_level": ["Cấp_bậc_công_việc", "JobLevel", "Grade"],
    "travel": ["Tần_suất_công_tác", "BusinessTravel", "Travel"],
    "overtime": ["Làm_thêm_giờ", "OverTime", "OT"],
    "income": ["ThuNhapHangThang_VND", "Thu_nhập_hàng_tháng", "MonthlyIncome", "Salary", "Income",
               "ThuNhap", "Wage"],
    "salary_hike": ["PhanTramTangLuong", "Tỷ_lệ_tăng_lương_phần_trăm", "PercentSalaryHike",
                    "SalaryHike"],
    "distance": ["KhoangCachNha_Km", "Khoảng_cách_từ_nhà", "DistanceFromHome", "Distance",
                 "Commute"],
    "job_satisfaction": ["HaiLong_CongViec", "Mức_hài_lòng_công_việc", "JobSatisfaction"],
    "env_satisfaction": ["HaiLong_MoiTruong", "Mức_hài_lòng_môi_trường", "EnvironmentSatisfaction"],
    "worklife": ["CanBangCongViec_CuocSong", "WorkLifeBalance", "WorkLife"],
    "involvement": ["Mức_độ_gắn_kết_công_việc", "JobInvolvement", "Engagement"],
    "relationship": ["HaiLong_QuanHe", "Mức_hài_lòng_mối_quan_hệ", "RelationshipSatisfaction"],
    "performance": ["Đánh_giá_hiệu_suất", "PerformanceRating", "Performance"],
    "training": ["SoLanDaoTao_Nam", "Số_lần_đào_tạo_năm_trước", "TrainingTimesLastYear"],
    "num_companies": ["Số_công_ty_đã_làm", "NumCompaniesWorked"],
    "total_experience": ["TongNamKinhNghiem", "Tổng_số_năm_làm_việc", "TotalWorkingYears",
                         "Experience"],
    "tenure": ["Số_năm_tại_công_ty", "YearsAtCompany", "Tenure"],
    "years_role": ["SoNam_ViTriHienTai", "Số_năm_ở_vai_trò_hiện_tại", "YearsInCurrentRole"],
    "years_promo": ["SoNam_TuLanThangChuc", "Số_năm_từ_lần_thăng_chức_gần_nhất",
                    "YearsSinceLastPromotion"],
    "years_manager": ["SoNam_VoiQuanLyHienTai", "Số_năm_làm_với_quản_lý_hiện_tại",
                      "YearsWithCurrManager"],
    "junk": ["EmployeeCount", "Số_lượng_nhân_viên", "StandardHours", "Số_giờ_tiêu_chuẩn", "Over18",
             "Trên_18_tuổi"],
}

# Short aliases that only match exactly.
EXACT_ONLY_ALIASES = ["id", "ot", "sex", "role", "level", "grade", "dept", "wage", "left", "status"]

# Roles offered as filters, in order of preference.
FILTER_ROLES = ["department", "location", "gender", "overtime", "job_role", "contract", "education"]

# Text that a CSV scan reads as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Encodings tried in order when a CSV file does not decode.
ENCODINGS = ["utf-8", "utf-8-sig", "latin-1", "cp1258", "cp1252"]
